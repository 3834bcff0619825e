"""Plan builders that combine operators into whole searches."""

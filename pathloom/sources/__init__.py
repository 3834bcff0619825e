"""Where rows come from: driver tables as namespaces, binary journal records, listings."""

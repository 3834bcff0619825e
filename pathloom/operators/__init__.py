"""DataFrame operators over namespaces, inventories and journals."""

"""Plans made on the driver from a network's structure: graph queries, elimination orders, structure search."""

"""flowloom: behaviour profiles for network-flow data, written as Spark jobs."""

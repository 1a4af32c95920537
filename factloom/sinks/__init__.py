"""Writers of the graph and its reports."""

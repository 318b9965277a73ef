"""Networks in files: GeNIe's XML, a plain text format, Graphviz."""

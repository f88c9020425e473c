"""Reading catalogs and tables, and writing rewritten tables."""

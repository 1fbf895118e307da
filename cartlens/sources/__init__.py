"""Where rows come from and where they go: CSV files, tables, stage tables, exports."""

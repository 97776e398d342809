"""DataFrame to DataFrame steps: preparation, numbering, merging, export, checks."""

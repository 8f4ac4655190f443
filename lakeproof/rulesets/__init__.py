"""Rule tables for text scans and rewrites: fixed values only."""

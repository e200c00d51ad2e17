"""Part of quillon: sources."""

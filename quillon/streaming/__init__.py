"""Part of quillon: streaming."""

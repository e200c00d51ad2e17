"""Part of quillon: plans."""

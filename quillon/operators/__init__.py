"""Part of quillon: operators."""

"""Part of quillon: functions."""

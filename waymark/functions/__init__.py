"""Part of waymark."""

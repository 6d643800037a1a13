"""Part of the cadenza package."""

"""Part of helixmill."""

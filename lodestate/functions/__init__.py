"""Part of the versioned-state engine."""

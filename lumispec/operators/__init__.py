"""Part of lumispec."""

"""Part of pitchflow."""

"""Part of tallyloom; see the README."""

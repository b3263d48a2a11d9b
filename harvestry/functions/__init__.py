"""Column transforms: text and pay rules."""

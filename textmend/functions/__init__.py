"""Column expressions: tables of code points and text rewrites and detectors over them."""

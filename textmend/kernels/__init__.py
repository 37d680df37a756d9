"""Sequential algorithms on one text at a time, run over Arrow batches by ``textmend.functions.arrow``."""

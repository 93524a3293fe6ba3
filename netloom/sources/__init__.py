"""Decoders of what devices send, capture files, and the text files an operator keeps."""

"""Training-data operators: the text fields of point and request records prepared for language models."""

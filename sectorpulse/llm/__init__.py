"""Training-data operators: tokens, chat text, quality, packing, archives and de-duplication."""

"""Training-data operators: language, quality, licences, URLs, chat, packing, duplicates, leaks, tokens."""

"""Training-data operators: deduplication, decontamination, archives, tokens, personal data, quality, languages, secrets, pages."""

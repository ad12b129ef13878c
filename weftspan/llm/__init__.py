"""Training-data operators: extraction, packing, records, classifiers,
decontamination, search and deduplication. Nothing else imports this package."""

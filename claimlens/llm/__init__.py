"""Training-data operators: deduplication, language, privacy, quality, toxicity,
mixing, decontamination and token files. Nothing else in the library imports
this subpackage."""

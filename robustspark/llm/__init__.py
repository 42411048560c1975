"""Corpus operators for training-data pipelines: quality, personal data, near-duplicates, leaks, media, HTML, repeats,
language-model scores and tokens. Nothing else in the library imports this subpackage."""

"""All queries of the core, by name."""

from captionflow.plans import corpus, entries, perturbed, records

QUERIES = {**corpus.QUERIES, **entries.QUERIES, **perturbed.QUERIES, **records.QUERIES}
ORACLE = {**corpus.ORACLE, **entries.ORACLE, **perturbed.ORACLE, **records.ORACLE}

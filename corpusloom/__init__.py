"""corpusloom: a PySpark engine that prepares and audits language-model text corpora."""

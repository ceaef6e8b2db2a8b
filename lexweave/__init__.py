"""Lexweave: bilingual lexicon induction and phrase-table scoring as Spark DataFrame plans."""

__version__ = "0.1.0"

"""Operators for preparing training corpora: packing, quality rules, decontamination,
binary token files, line / n-gram / substring deduplication, language identification,
chat formatting.  Nothing else in the library imports this subpackage.

Conventions shared by all operators
-----------------------------------
* Every input row is one document.  Rows that repeat (same id and text) are documents
  of their own and each gets its own result row.
* A null text is an empty text.  A null id is allowed; it sorts before every other id.
* Only the columns an operator names are read; extra columns never clash with its own.
"""

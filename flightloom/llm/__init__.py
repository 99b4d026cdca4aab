"""Operators for building training corpora: deduplication, language and licence
detection, tokenising, pseudonyms, nearest neighbours, image copies and mixing.

Nothing outside this subpackage imports it."""

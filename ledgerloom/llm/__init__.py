"""Optional operators for text corpora and mergeable statistics; nothing outside this subpackage imports it."""

"""Ten operators for building training data from a document table; nothing outside this folder imports it."""

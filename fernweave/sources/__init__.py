"""Reading documents, questions and indexes, and writing indexes and reports."""

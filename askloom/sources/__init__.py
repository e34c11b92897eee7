"""Readers and writers of the file formats around a question-and-answer archive."""

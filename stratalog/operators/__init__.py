"""Relational operators over episodes, messages, attachments and samples."""

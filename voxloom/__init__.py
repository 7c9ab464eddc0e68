"""Conversation and document analytics on PySpark."""

"""Relational, sequence and reshaping operators as functions of relations."""

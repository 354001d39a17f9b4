"""Tessera: text mining, evidence and matching as Spark DataFrame operators."""

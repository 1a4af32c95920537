"""Evaluation of every stage against labels."""

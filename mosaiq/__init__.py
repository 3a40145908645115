"""Persona analytics as Spark jobs: vectors, labels, scores, samples, selections, text diversity."""

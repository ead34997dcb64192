"""Curata: curate, sample, assemble and evaluate structured record collections on Spark."""

"""Genotype x environment analytics and corpus operators on Spark DataFrames."""

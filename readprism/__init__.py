"""Sequencing-read quality control as Spark DataFrames."""

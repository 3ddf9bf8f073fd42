"""Labelled-corpus, embedding and evaluation analytics as functions of DataFrames."""

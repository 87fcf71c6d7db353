"""Analytics over build graphs, content-addressed trees and provenance, and over training text, on Spark."""

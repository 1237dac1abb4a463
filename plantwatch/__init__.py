"""Monitoring analytics as Spark jobs: audit, split, profile, train, evaluate,
validate, score, explain and fuse machine and network signals per asset."""

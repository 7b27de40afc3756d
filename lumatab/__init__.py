"""lumatab: profiling, privacy, rules and fidelity operators as lazy Spark plans."""

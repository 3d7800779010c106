"""Table readers, landing-file parsers and sinks."""

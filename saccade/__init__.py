"""saccade: analytics over high-rate spatio-temporal event streams, as Spark DataFrame operators."""

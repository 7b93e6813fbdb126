"""Feed streams: normalisation, gates by key, sinks, activity maps."""

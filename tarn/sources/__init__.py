"""Table loaders, file readers and sinks."""

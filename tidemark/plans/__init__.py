"""Plan helpers: checkpoints, size-checked broadcasts, and the query registry."""

"""Plan helpers: sessions, shared scratch storage, size-checked broadcasts, running sums."""

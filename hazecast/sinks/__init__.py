"""Writers and table maintenance: upsert, CSV backup merge, batched writes, deletes, reloads."""

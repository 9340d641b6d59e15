"""Jobs over streams of files: day metrics, unique visitors, the rolling pool, score inertia and a learning ledger."""

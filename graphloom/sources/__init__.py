"""Where graphs come from: file trees, diffs, snapshots, extractors and a projection of star-schema tables."""

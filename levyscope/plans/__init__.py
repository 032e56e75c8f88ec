"""Named pipelines of the study."""

"""editlake: edit-effect pair analytics and corpus preparation as Spark jobs."""

"""Sources and sinks; all read through Spark's readers, so any file system that Spark knows will do."""

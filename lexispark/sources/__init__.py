"""Readers and writers: utterance folders, manifests, transcript formats and tables. Paths go to Spark's readers, so any file system it knows will do."""

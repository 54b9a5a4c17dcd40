"""Spark jobs for keyframe selection, review and retrieval over large video collections."""

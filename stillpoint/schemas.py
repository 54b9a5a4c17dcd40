"""Schemas of the record kinds. Times are double seconds from the start of a video."""

EVENTS = "video_ord long, video_id string, t double, source string, score double, ord long"
CANDIDATES = (
    "candidate_id string, video_id string, video_path string, timestamp_seconds double, image_path string, "
    "source string, score double, decision string, metadata string, ord long"
)
KEYFRAMES = (
    "keyframe_id string, candidate_id string, video_id string, video_path string, timestamp_seconds double, "
    "image_path string, source string, score double, metadata string, ord long"
)
DECISIONS = ("pending", "accepted", "rejected")
VIDEO_SUFFIXES = ("avi", "m4v", "mkv", "mov", "mp4", "mpeg", "mpg", "webm")

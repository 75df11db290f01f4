"""framestory - visual-event analytics on Spark DataFrames.

Detections from many cameras go in; tracks, motion profiles, semantic events,
story chains and a budgeted selection of whole chains come out.  Every table
carries ``video_id`` and every per-video quantity is a partitioned one.
"""

__version__ = "0.1.0"

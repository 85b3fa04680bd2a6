"""Schemas of the stored tables."""

LABELS_JSON = "MAP<STRING, MAP<STRING, ARRAY<STRUCT<start: INT, end: INT, present: BOOLEAN>>>>"
ANNOTATIONS_JSON = (
    "ARRAY<STRUCT<start: INT, end: INT, tag: STRING, color: STRING, description: STRING, identity: INT>>"
)
DOCUMENT_JSON = (
    f"file STRING, num_frames INT, labels {LABELS_JSON}, unfragmented_labels {LABELS_JSON}, "
    f"annotations {ANNOTATIONS_JSON}"
)
FRAME_KEYPOINTS = "frame_index BIGINT, keypoints ARRAY<ARRAY<DOUBLE>>, confidence DOUBLE"
KEYPOINT_ANNOTATION = (
    "keypoints ARRAY<ARRAY<DOUBLE>>, kept_frame_indices ARRAY<BIGINT>, mean_confidence DOUBLE"
)
INFERENCE_RUN = """
    video STRUCT<path: STRING, width: BIGINT, height: BIGINT, fps: DOUBLE, frame_count: BIGINT>,
    model STRUCT<checkpoint_path: STRING, backbone: STRING, num_keypoints: BIGINT,
        input_size: ARRAY<BIGINT>, output_stride: BIGINT, decode_use_dark: BOOLEAN, decode_sigma: DOUBLE>,
    sampling STRUCT<num_frames: BIGINT, frame_indices: ARRAY<BIGINT>, strategy: STRING>,
    aggregation STRUCT<confidence_threshold: DOUBLE, confidence_metric: STRING, method: STRING>,
    created_at STRING, extra STRING
"""

"""Errors of loading and parsing; the same codes appear in error columns."""


class SegmentationError(Exception):
    code = "Error"


class InvalidUtf8(SegmentationError):
    code = "InvalidUtf8"


class ModelNotLoaded(SegmentationError):
    code = "ModelNotLoaded"


class UnsupportedModelFormat(SegmentationError):
    code = "UnsupportedModelFormat"


class MalformedModel(SegmentationError):
    code = "MalformedModel"


class MalformedCorpus(SegmentationError):
    code = "MalformedCorpus"


class IoError(SegmentationError):
    code = "IoError"

"""Errors of the file formats. Readers raise them (``mode=FAILFAST``) or put them into a warnings column (``PERMISSIVE``)."""


class SkyError(Exception):
    """Base of all format errors."""


class FitsError(SkyError):
    pass


class FitsHeaderError(FitsError):
    pass


class FitsDataError(FitsError):
    pass


class DecompressionError(FitsError):
    pass


class SerError(SkyError):
    pass


class SerParseError(SerError):
    pass


class SerValidationError(SerError):
    pass


class XisfError(SkyError):
    pass


class XisfParseError(XisfError):
    pass


class XisfValidationError(XisfError):
    pass


class XisfChecksumError(XisfError):
    pass


class XisfSignatureError(XisfError):
    pass


class XisfResourceError(XisfError):
    pass


class HipsError(SkyError):
    pass


class NetworkTimeoutError(SkyError):
    pass

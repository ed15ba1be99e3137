"""What can be wrong with packs and references."""


class PackError(Exception):
    """Anything a user can put right."""


class CompressedMember(PackError):
    """A member isn't stored as it is, so its bytes have no place of their own."""


class ForbiddenMember(PackError):
    """A member uses a feature that packs don't allow, such as encryption."""


class CorruptPack(PackError):
    """A shard's directory, headers and payloads don't agree."""


class UnknownBlob(PackError, KeyError):
    """A key or reference names nothing in this pack."""

    __str__ = Exception.__str__

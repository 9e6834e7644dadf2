"""Rule packs as data."""

from . import csharp_pack, java_pack, javascript_pack, python_pack
from .csharp_pack import SERVICE_RULES
from .model import Rule

#: language -> rules in evaluation order
PACKS = {
    "python": python_pack.RULES,
    "java": java_pack.RULES,
    "csharp": csharp_pack.RULES,
    "javascript": javascript_pack.RULES,
}

#: the pack that the C# analysis service applies on its side
SERVICE_PACK = {"csharp": SERVICE_RULES}

__all__ = ["PACKS", "SERVICE_PACK", "Rule"]

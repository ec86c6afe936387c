from paritas.functions import bits, fixedpoint, hashing, intervals

__all__ = ["bits", "fixedpoint", "hashing", "intervals"]

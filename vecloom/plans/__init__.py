from vecloom.plans.psth import psth

__all__ = ["psth"]

"""Information-theoretic measures as Spark plans."""

from .api import (
    conditional_entropy,
    conditional_mutual_information,
    conditional_transfer_entropy,
    cross_entropy,
    entropy,
    joint_entropy,
    js_divergence,
    kl_divergence,
    local_entropy,
    local_mutual_information,
    mutual_information,
    transfer_entropy,
)
from .operators.discrete import Estimator, register_entropy

__all__ = [
    "Estimator",
    "conditional_entropy",
    "conditional_mutual_information",
    "conditional_transfer_entropy",
    "cross_entropy",
    "entropy",
    "joint_entropy",
    "js_divergence",
    "kl_divergence",
    "local_entropy",
    "local_mutual_information",
    "mutual_information",
    "register_entropy",
    "transfer_entropy",
]

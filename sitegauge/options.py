"""What an analysis is allowed to do and where it asks, as one immutable object."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field

from .operators.judgment import provider_of


@dataclass(frozen=True)
class Options:
    """Rendering, regions and judgments are off unless switched on; without a key or a worker they stay off."""

    enable_render: bool = False
    enable_geo: bool = False
    enable_llm: bool = False
    llm_provider: str = "mock"
    llm_model: str = "llama-3.3-70b-versatile"
    llm_keys: Mapping[str, str] = field(default_factory=dict, repr=False)
    llm_endpoints: Mapping[str, str] = field(default_factory=dict)
    workers: tuple[str, ...] = ()
    page_timeout: float = 10.0
    probe_timeout: float = 15.0
    llm_timeout: float = 30.0

    @property
    def provider(self) -> str:
        """The provider that answers; mock, which doesn't, where the key is missing."""
        return provider_of(self.llm_provider, self.llm_keys.get(self.llm_provider.lower()))

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Options:
        """From variables such as ENABLE_LLM, LLM_PROVIDER, GROQ_API_KEY and GEO_WORKER_URL_US; empty worker URLs don't count."""
        env = os.environ if env is None else env
        on = lambda name: env.get(name, "false").lower() == "true"
        workers = [env.get(f"GEO_WORKER_URL_{r}", "") for r in ("US", "EU", "APAC")]
        return cls(
            enable_render=on("ENABLE_RENDER"), enable_geo=on("ENABLE_GEO_CHECK"), enable_llm=on("ENABLE_LLM"),
            llm_provider=env.get("LLM_PROVIDER", "mock").lower(), llm_model=env.get("LLM_MODEL", cls.llm_model),
            llm_keys={p: env.get(f"{p.upper()}_API_KEY", "") for p in ("groq", "gemini")}, workers=tuple(w for w in workers if w),
        )

"""Roles of the columns in a fact table, so operators do not name columns."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EntityKey:
    """A client identifier: the columns that make it up, coarse column first.

    With `missing=None` rows that lack a column have no entity and get NULL
    history. With a text, that text stands for the absent value.
    """

    name: str
    columns: tuple[str, ...]
    missing: str | None = None


@dataclass(frozen=True)
class DatasetSpec:
    id: str
    time: str
    amount: str
    target: str
    entity_keys: tuple[EntityKey, ...] = ()
    missing_flags: tuple[str, ...] = ()
    domains: tuple[str, ...] = ()
    day_offsets: tuple[str, ...] = ()
    frequency_columns: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    numeric: tuple[str, ...] = ()
    context: tuple[str, ...] = ()

    @property
    def required(self) -> tuple[str, ...]:
        return (self.id, self.target, self.time, self.amount)


# Column roles of the public card-payment dataset.
CARD_PAYMENTS = DatasetSpec(
    id="TransactionID",
    time="TransactionDT",
    amount="TransactionAmt",
    target="isFraud",
    entity_keys=(
        EntityKey("card1", ("card1",)),
        EntityKey("uid", ("card1", "addr1", "D1n"), "na"),
        EntityKey("uid2", ("card1", "addr1", "D1n", "card2", "card3"), "na"),
    ),
    missing_flags=(
        "id_01", "id_02", "id_03", "id_04", "id_05", "id_09", "id_13", "id_31",
        "DeviceType", "DeviceInfo", "dist1", "dist2", "D1", "D15", "addr1", "P_emaildomain",
    ),
    domains=("P_emaildomain", "R_emaildomain"),
    day_offsets=tuple(f"D{i}" for i in range(1, 16)),
    frequency_columns=(
        "card1", "card2", "card3", "card5", "addr1", "addr2",
        "P_emaildomain", "R_emaildomain", "DeviceInfo", "id_31", "id_30",
    ),
    categorical=(
        "ProductCD", "card4", "card6", "P_emaildomain", "R_emaildomain",
        "M1", "M2", "M3", "M4", "M5", "M6", "M7", "M8", "M9", "DeviceType", "id_31", "id_30",
    ),
    numeric=("TransactionAmt", "dist1", "dist2", "C1", "C13", "C14", "D1", "D15"),
    context=("ProductCD", "card4", "card6", "DeviceType"),
)

EVENT_STREAM = DatasetSpec(
    id="txn_id",
    time="t",
    amount="amount",
    target="label",
    entity_keys=(EntityKey("client", ("client",)), EntityKey("pair", ("client", "channel"))),
    missing_flags=("k_obs", "dist"),
    frequency_columns=("client", "channel", "k_obs"),
    categorical=("channel", "band"),
    numeric=("amount", "k_obs", "dist"),
    context=("channel", "band"),
)

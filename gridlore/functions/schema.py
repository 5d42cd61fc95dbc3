"""Plan-time schema work: column kinds, header names and semantic roles. No Spark job."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, types as T

# Keyword sets that name the role of a column.
ROLE_KEYWORDS: dict[str, dict[str, tuple[str, ...]]] = {
    "sales": {
        "customer": ("customer", "pelanggan", "client", "klien", "buyer", "pembeli",
                     "customer name", "nama pelanggan"),
        "product": ("product", "produk", "item", "barang", "service", "layanan", "sku",
                    "description", "deskripsi"),
        "revenue": ("revenue", "pendapatan", "amount", "jumlah", "total", "sales",
                    "penjualan", "price", "harga", "value", "nilai"),
        "quantity": ("quantity", "qty", "jumlah", "unit", "pcs"),
        "date": ("date", "tanggal", "order date", "transaction", "transaksi", "tgl",
                 "invoice date", "period", "periode"),
        "region": ("region", "wilayah", "city", "kota", "state", "provinsi", "country",
                   "negara", "area", "cabang", "branch"),
        "category": ("category", "kategori", "type", "tipe", "group", "grup", "segment",
                     "segmen"),
        "profit": ("profit", "laba", "margin", "keuntungan", "gross profit"),
    },
    "people": {
        "employee": ("employee", "karyawan", "name", "nama", "staff", "pegawai",
                     "employee name", "full name", "nama lengkap", "person", "pekerja"),
        "salary": ("salary", "gaji", "wage", "upah", "income", "pendapatan", "pay",
                   "compensation", "kompensasi", "base pay"),
        "department": ("department", "departemen", "dept", "division", "divisi", "unit",
                       "bagian", "team", "tim"),
        "location": ("location", "lokasi", "office", "kantor", "branch", "cabang", "city",
                     "kota", "site"),
        "overtime": ("overtime", "lembur", "ot", "hours", "jam kerja", "extra hours",
                     "extra time"),
        "attendance": ("attendance", "absensi", "hadir", "present", "absent", "absen",
                       "sick", "sakit", "leave", "cuti", "late", "telat"),
        "date": ("date", "tanggal", "period", "periode", "month", "bulan", "year", "tahun"),
        "position": ("position", "posisi", "jabatan", "role", "peran", "title", "grade",
                     "level"),
        "productivity": ("productivity", "produktivitas", "kpi", "performance", "kinerja",
                         "target", "achievement", "capaian"),
    },
    "inventory": {
        "item": ("item", "product", "produk", "barang", "name", "nama", "sku", "material",
                 "description", "part"),
        "stock": ("stock", "stok", "quantity", "qty", "jumlah", "on hand", "current stock",
                  "balance", "remaining"),
        "price": ("price", "harga", "cost", "biaya", "value", "nilai", "unit price",
                  "unit cost", "harga satuan"),
        "location": ("location", "lokasi", "warehouse", "gudang", "storage", "penyimpanan",
                     "shelf", "rak"),
        "date": ("date", "tanggal", "received", "diterima", "in date", "purchase date",
                 "beli", "entry date", "masuk"),
        "category": ("category", "kategori", "type", "tipe", "group", "grup", "class",
                     "kelas"),
        "movement": ("movement", "sold", "terjual", "out", "keluar", "usage", "pemakaian",
                     "demand"),
    },
    "finance": {
        "revenue": ("revenue", "pendapatan", "sales", "penjualan", "income", "omset"),
        "cogs": ("cogs", "cost of goods sold", "hpp", "cost of sales", "harga pokok",
                 "beban pokok"),
        "profit": ("profit", "laba", "net income", "laba bersih", "earning", "net profit",
                   "gross profit", "laba kotor"),
        "expense": ("expense", "beban", "cost", "biaya", "operating expense"),
        "asset": ("asset", "aset", "total asset", "total aset"),
        "liability": ("liability", "liabilitas", "utang", "kewajiban"),
        "equity": ("equity", "ekuitas", "modal"),
        "current_asset": ("current asset", "aset lancar"),
        "current_liability": ("current liability", "utang lancar",
                              "liabilitas jangka pendek"),
        "inventory": ("inventory", "persediaan", "stock", "inventaris"),
        "receivable": ("receivable", "piutang", "account receivable"),
        "date": ("date", "tanggal", "period", "periode", "tahun", "year", "month", "bulan"),
    },
}

_KINDS = {
    "numeric": T.NumericType,
    "text": T.StringType,
    "date": (T.TimestampType, T.TimestampNTZType, T.DateType),
    "boolean": T.BooleanType,
}


def columns_of(df: DataFrame, kind: str) -> list[str]:
    """Names of the numeric / text / date / boolean columns, in table order."""
    wanted = _KINDS[kind]
    return [f.name for f in df.schema.fields if isinstance(f.dataType, wanted)]


def name_tokens(name: str) -> list[str]:
    """Lower-case words of a column name; splits on symbols and camel humps."""
    spaced = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", str(name))
    return re.findall(r"[^\W_]+", spaced.lower())


def has_keyword(name: str, keyword: str) -> bool:
    """True if the keyword's words stand side by side in the name (a plural s is allowed)."""
    words, wanted = name_tokens(name), keyword.split()
    size = len(wanted)
    for start in range(len(words) - size + 1):
        window = words[start:start + size]
        if all(w == k or w == k + "s" for w, k in zip(window, wanted)):
            return True
    return False


def detect_roles(
    df: DataFrame, domain: str, overrides: Mapping[str, str] | None = None
) -> dict[str, str]:
    """Role -> column. Overrides win; longer keywords are matched before shorter ones,
    on whole words, and a column holds one role only."""
    chosen = dict(overrides or {})
    unknown = set(chosen) - set(ROLE_KEYWORDS[domain])
    if unknown:
        raise ValueError(f"unknown {domain} roles: {sorted(unknown)}")
    for column in chosen.values():
        if column not in df.columns:
            raise ValueError(f"no column {column!r}")
    ranked = sorted(
        (
            (-len(keyword.split()), -len(keyword), order, role, keyword)
            for order, (role, keywords) in enumerate(ROLE_KEYWORDS[domain].items())
            for keyword in keywords
        )
    )
    for *_, role, keyword in ranked:
        if role in chosen:
            continue
        taken = set(chosen.values())
        for column in df.columns:
            if column not in taken and has_keyword(column, keyword):
                chosen[role] = column
                break
    return chosen


def unique_names(names: Iterable[str | None]) -> list[str]:
    """Missing names become Column_i; repeats get _1, _2, ... until they are unique."""
    wanted = ["Column_%d" % i if n is None else str(n) for i, n in enumerate(names)]
    out: list[str] = []
    used: set[str] = set()
    for name in wanted:
        candidate, k = name, 0
        while candidate in used or (k and candidate in wanted):
            k += 1
            candidate = f"{name}_{k}"
        used.add(candidate)
        out.append(candidate)
    return out


def normalize_headers(df: DataFrame, names: Iterable[str | None] | None = None) -> DataFrame:
    """The same table under unique, non-missing column names."""
    return df.toDF(*unique_names(df.columns if names is None else names))

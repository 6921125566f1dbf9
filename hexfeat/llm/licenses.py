"""Licence scans with built-in functions only.

Paragraphs that hold one of the anchor words are turned into word n-grams (one to three words) around the anchors, and a
multinomial logistic regression over the hashed n-grams names the licence family. It is trained here, on the notices
below and on variants of them with words left out; a class of its own, `unknown`, learns sentences that use the same
words for other things. The probability from which a paragraph is believed to be a notice at all is calibrated on
notices and sentences the fit has not seen.
A prediction is then held against the family's notices: it is confirmed if enough of the n-grams of the paragraph, or of
a notice, are found in the other. Features only exist around anchors, so a paragraph without any is `unknown` by
construction, and the scan looks no further at it.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UNKNOWN = "unknown"
DIMENSIONS, TARGET_PRECISION, CONFIRMED_FROM = 1 << 14, 0.99, 0.5
#: Beginnings of the words without which no notice is written, in lower case; lines are filtered and features made by the same.
ANCHOR = r"(?:licen[cs]|lizen[sz]|copy(?:right|left)|permi(?:ssion|so)|redistribu|warrant|spdx|creative|apache|mozilla|reserv(?:ed|ad)|réserv|vorbehalten|propriet|propietari|domain|dominio|gemeinfrei|[al]?gpl|unlicense|gnu|(?:cc|mit|bsd|mpl|isc)(?:v?\d|\b))"
#: Names that are written in one word with their version: gplv3, lgpl2, cc0.
_VERSIONED = r"\b([al]?gpl|mpl|bsd|cc)[_]?(v?\d)"
#: Notices of each family, and sentences of none, by which the model is trained.
NOTICES = {
    "mit": ["Dieses Projekt steht unter der MIT-Lizenz.", "Veröffentlicht unter der MIT-Lizenz.", "Este proyecto se distribuye bajo la licencia MIT.", "Publicado bajo la Licencia MIT.", "Ce projet est distribué sous licence MIT.", "Publié sous la licence MIT.", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "Released under the MIT License.", "Licensed under the MIT license.", "This project is licensed under the terms of the MIT license.", "SPDX-License-Identifier: MIT", "The MIT License (MIT)", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.", "Distributed under the MIT License. See LICENSE for details."],
    "apache-2.0": ["Lizenziert unter der Apache-Lizenz, Version 2.0.", "Licenciado bajo la Licencia Apache, Versión 2.0.", "Sous licence Apache, version 2.0.", "Distribué sous la licence Apache 2.0.", "Veröffentlicht unter der Apache License 2.0.", "Publicado bajo la licencia Apache 2.0.", "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0", "Apache License Version 2.0, January 2004", "This software is released under the Apache 2.0 license.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "gpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "Dieses Programm ist freie Software und steht unter der GNU General Public License.", "Veröffentlicht unter der GPL, Version 3.", "Este programa es software libre bajo la Licencia Pública General de GNU.", "Publicado bajo la licencia GPL.", "Ce programme est un logiciel libre sous la Licence publique générale GNU.", "Distribué sous licence GNU GPL version 3.", "Publié sous licence GPL.", "This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.", "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-2.0-only", "Released under the GNU GPL v3.", "Released under GPLv3.", "GPLv2 or later", "You should have received a copy of the GNU General Public License along with this program.", "Licensed under the GNU General Public License version 2 or later."],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "You should have received a copy of the GNU Lesser General Public License along with this library.", "GNU Lesser General Public License version 3 or later", "Diese Bibliothek steht unter der GNU Lesser General Public License.", "Esta biblioteca se distribuye bajo la licencia LGPL.", "Cette bibliothèque est distribuée sous licence LGPL.", "Veröffentlicht unter der LGPL.", "Licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-or-later", "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License.", "Released under the LGPL v3.", "Released under LGPLv3.", "under LGPLv3"],
    "agpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "You should have received a copy of the GNU Affero General Public License along with this program.", "Released under AGPLv3.", "Veröffentlicht unter der AGPL, Version 3.", "Publicado bajo la licencia AGPL.", "Distribué sous licence AGPL.", "Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only", "Released under the GNU AGPL v3.", "Free software under the terms of the GNU Affero General Public License."],
    "bsd": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation.", "Veröffentlicht unter der BSD-Lizenz.", "Publicado bajo la licencia BSD.", "Distribué sous licence BSD.", "Licensed under the BSD license.", "Distributed under the BSD license.", "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Use of this source code is governed by a BSD-style license.", "Released under the BSD 2-Clause license."],
    "mpl": ["Veröffentlicht unter der Mozilla Public License 2.0.", "Publicado bajo la licencia pública de Mozilla, versión 2.0.", "Distribué sous la licence publique Mozilla, version 2.0.", "Distributed under the Mozilla Public License.", "Released under the Mozilla Public License 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0", "Licensed under the Mozilla Public License, version 2.0.", "Released under the MPL 2.0."],
    "isc": ["Distributed under the terms of the ISC license.", "Veröffentlicht unter der ISC-Lizenz.", "Publicado bajo la licencia ISC.", "Distribué sous licence ISC.", "Licensed under the ISC License.", "SPDX-License-Identifier: ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "Released under the ISC license."],
    "cc-by": ["Dieses Werk ist lizenziert unter einer Creative Commons Namensnennung 4.0 International Lizenz.", "Esta obra está bajo una Licencia Creative Commons Atribución 4.0 Internacional.", "Cette œuvre est mise à disposition selon les termes de la Licence Creative Commons Attribution 4.0 International.", "Published under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0", "This article is distributed under the terms of the Creative Commons Attribution License.", "Available under CC BY 3.0."],
    "cc-by-sa": ["Dieses Werk ist lizenziert unter einer Creative Commons Namensnennung - Weitergabe unter gleichen Bedingungen 4.0 International Lizenz.", "Esta obra está bajo una Licencia Creative Commons Atribución-CompartirIgual 4.0 Internacional.", "Cette œuvre est mise à disposition selon les termes de la Licence Creative Commons Attribution - Partage dans les Mêmes Conditions 4.0 International.", "Published under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0.", "SPDX-License-Identifier: CC-BY-SA-4.0", "Text is available under the Creative Commons Attribution-ShareAlike License.", "Available under CC BY-SA 3.0."],
    "cc-by-nc": ["Dieses Werk ist lizenziert unter einer Creative Commons Namensnennung - Nicht kommerziell 4.0 International Lizenz.", "Esta obra está bajo una Licencia Creative Commons Atribución-NoComercial 4.0 Internacional.", "Cette œuvre est mise à disposition selon les termes de la Licence Creative Commons Attribution - Pas d'Utilisation Commerciale 4.0 International.", "Published under CC BY-NC 4.0.", "Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0", "Available under CC BY-NC 3.0.", "Shared under the Creative Commons Attribution-NonCommercial license."],
    "public-domain": ["This text is in the public domain.", "Dieses Werk ist gemeinfrei.", "Der Text ist gemeinfrei und frei verwendbar.", "Esta obra es de dominio público.", "Este texto está en el dominio público.", "Cette œuvre est dans le domaine public.", "Texte placé dans le domaine public.", "This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: CC0-1.0", "SPDX-License-Identifier: Unlicense", "This work has been dedicated to the public domain.", "Released into the public domain under CC0 1.0 Universal.", "Released under CC0 1.0."],
    "proprietary": ["Alle Rechte vorbehalten.", "Copyright 2020 bei den Autoren. Alle Rechte vorbehalten.", "Todos los derechos reservados.", "Copyright 2020 de los autores. Todos los derechos reservados.", "Tous droits réservés.", "Copyright 2020 des auteurs. Tous droits réservés.", "All rights reserved.", "Copyright 2020 by the authors. All rights reserved.", "This document is proprietary and confidential.", "No part of this publication may be reproduced without the prior written permission of the publisher.", "Proprietary and confidential. Unauthorized copying is prohibited."],
    UNKNOWN: ["Er hat seine Lizenz als Trainer verloren.", "Die Lizenz des Senders lief im Mai aus.", "Änderungen sind vorbehalten.", "Er hat den Führerschein, aber keine Lizenz zum Fliegen.", "Perdió su licencia de conducir la semana pasada.", "Pidió permiso para salir de la sala.", "Las mesas reservadas estaban vacías.", "El dominio del equipo fue total.", "Il a perdu sa licence de pêche.", "Elle prépare une licence de lettres.", "Une table est réservée pour quatre personnes.", "Ce domaine produit du vin rouge.", "Le propriétaire de la maison est absent.", "La propriété est à vendre.", "The public domain of ideas was discussed.", "Der Verein erhielt die Lizenz für die neue Saison.", "El permiso de obras fue denegado.", "La redistribución de la renta fue debatida.", "He lost his driver license last week.", "She asked for permission to leave the room early.", "The restaurant was denied a liquor license by the city.", "The warranty covers parts for two years.", "A table was reserved for four people.", "The domain name expired in March.", "Students at MIT built a creative robot.", "The apache helicopter landed near the base.", "A licensed physician must sign the form.", "Copyright law is taught in the second year.", "The poetic licence of the author is wide.", "You need a fishing license at this lake.", "The license plate was stolen.", "The licensing board met on Monday.", "Mail was sent with a cc to the manager.", "Permission was refused by the council.", "The gnu is a large animal of the plains.", "Redistribution of income was debated.", "Proprietary drugs cost more than generic ones.", "They licensed the song for a film.", "The license of the software is not stated.", "The domain of the function is the set of real numbers.", "She spoke with the permission of the court and the reserved seats were full."],
}


def words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), _VERSIONED, "$1 $2"), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def grams(tokens: str) -> Column:
    """Distinct n-grams of one to three words, those within two words of an anchor, or at the beginning with one among the first five. tokens is a column, not an expression: lambdas would compute that anew for each word."""
    tokens = F.col(tokens)
    anchors = F.filter(F.sequence(F.lit(1), F.size(tokens)), lambda i: F.element_at(tokens, i).rlike("^" + ANCHOR))
    near = F.array_distinct(F.flatten(F.transform(anchors, lambda i: F.sequence(F.when(i <= 5, 1).otherwise(i - 2), F.least(i + 2, F.size(tokens))))))
    n_grams = F.flatten(F.transform(near, lambda i: F.array(*[F.array_join(F.slice(tokens, i, k), " ") for k in (1, 2, 3)])))
    return F.when(F.size(tokens) > 0, F.array_distinct(n_grams)).otherwise(F.array().cast("array<string>"))


def notices(spark: SparkSession) -> DataFrame:
    """family, notice and grams of the notices."""
    rows = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(t).alias("notice")) for f, texts in NOTICES.items() for t in texts])
    return spark.range(1).select(F.explode(rows).alias("x")).select("x.family", "x.notice").withColumn("tokens", words(F.col("notice"))).select("family", "notice", grams("tokens").alias("grams"))


def variants(known: DataFrame) -> DataFrame:
    """Each notice, and its variants without one word; `fold` deals whole notices to fitting (0 to 3) and calibration (4)."""
    tokens = words(F.col("notice"))
    at = F.explode(F.concat(F.array(F.lit(0)), F.when(F.size(tokens) > 4, F.sequence(F.lit(1), F.size(tokens))).otherwise(F.array().cast("array<int>")))).alias("gone")
    dealt = known.select("family", "notice", at).withColumn("tokens", F.filter(tokens, lambda w, i: i + 1 != F.col("gone")))
    return dealt.select("family", grams("tokens").alias("grams"), F.pmod(F.xxhash64("notice"), F.lit(5)).alias("fold"))


class Licences:
    """A fitted model: the regression, its families in order, and the least probability that is believed."""

    def __init__(self, model: LogisticRegressionModel, families: list[str], believed_from: float):
        self.model, self.families, self.believed_from = model, families, believed_from

    def predict(self, rows: DataFrame) -> DataFrame:
        """rows (with grams) and the columns family and probability of the likeliest class."""
        hashed = HashingTF(inputCol="grams", outputCol="features", numFeatures=DIMENSIONS, binary=True).transform(rows)
        scored = self.model.transform(hashed).withColumn("all", vector_to_array("probability"))
        names = F.array(*[F.lit(f) for f in self.families])
        return scored.select(*rows.columns, F.array_max("all").alias("probability_"), F.element_at(names, F.array_position("all", F.array_max("all")).cast("int")).alias("family_"))


def fit(spark: SparkSession) -> Licences:
    families = sorted(NOTICES)
    known = variants(notices(spark)).withColumn("label", (F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family")) - 1).cast("double"))
    hashed = HashingTF(inputCol="grams", outputCol="features", numFeatures=DIMENSIONS, binary=True).transform(known).cache()  # the variants of the notices above; both fits and the calibration read them
    regression = LogisticRegression(family="multinomial", regParam=1e-3, maxIter=40)
    found = Licences(regression.fit(hashed.filter("fold < 4")), families, 0.5)
    seen = found.predict(hashed.drop("features").filter("fold = 4").withColumnRenamed("family", "truth")).filter(F.col("family_") != UNKNOWN)
    # The least probability above which texts that the fit hasn't seen are notices, not unknown, often enough; which family it is, the templates confirm. Then all are fitted.
    ranked = seen.select("probability_", (F.col("truth") != UNKNOWN).cast("int").alias("right")).collect()  # a few hundred variants of the notices above
    right = total = 0
    believed = 0.5
    for row in sorted(ranked, key=lambda r: -r["probability_"]):
        right, total = right + row["right"], total + 1
        if right < TARGET_PRECISION * total:
            break
        believed = row["probability_"]
    model = regression.fit(hashed)
    hashed.unpersist()
    return Licences(model, families, max(0.3, float(believed)))


#: Found in every lower-case line that holds an anchor.
_LINE = r"\b" + ANCHOR
_SENTENCE_END, _BETWEEN = r"([.!?])[\x20\t\r]*\n", r"\n[\x20\t\r]*\n"


def scan_licenses(docs: DataFrame, model: Licences) -> DataFrame:
    """doc_id, family, probability, families and n_paragraphs of every row of docs (doc_id, text).

    Paragraphs end at blank lines and at lines that end a sentence, so wrapped lines are read together; the lines of a
    paragraph that names nothing are read one by one. family is the likeliest confirmed one (of equally likely ones the
    last by name), families all of them, sorted and joined by commas,
    n_paragraphs how many paragraphs name one; `unknown`, null, empty and 0 where there is none. A null text has no
    paragraph, a null doc_id stays null, rows that repeat a doc_id are answered one by one, an empty table gives an
    empty result, other columns are not read. Long texts are read whole; of a text only the n-grams of paragraphs with an anchor are shuffled.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    anchored = lambda parts: F.filter(parts, lambda x: x.rlike(_LINE))
    held = rows.select("doc_id", F.when(F.lower("text").rlike(_LINE), anchored(F.split(F.regexp_replace(F.lower("text"), _SENTENCE_END, "$1\n\n"), _BETWEEN))).alias("paragraphs"))
    paragraphs = held.withColumn("key", F.monotonically_increasing_id()).select("key", "doc_id", F.posexplode_outer("paragraphs").alias("at", "paragraph"))
    # The whole paragraph first; its lines are for the case that it names nothing.
    whole = F.coalesce("paragraph", F.lit(""))
    units = F.when(whole.contains("\n"), F.concat(F.array(whole), anchored(F.split(whole, "\n")))).otherwise(F.array(whole))
    parts = paragraphs.select("key", "doc_id", "at", F.posexplode(units).alias("line", "unit")).withColumn("tokens", words(F.col("unit"))).select("key", "doc_id", "at", "line", grams("tokens").alias("grams"))
    known = notices(spark).filter(F.col("family") != UNKNOWN).groupBy("family").agg(F.collect_list("grams").alias("notices"))
    named = model.predict(parts).join(F.broadcast(known), F.col("family_") == F.col("family"), "left")
    alike = F.array_max(F.transform("notices", lambda n: F.size(F.array_intersect(n, F.col("grams"))) / F.least(F.size(n), F.size("grams"))))
    sure = (F.col("probability_") >= model.believed_from) & (F.coalesce(alike, F.lit(0.0)) >= CONFIRMED_FROM)
    judged = named.repartition("key").withColumn("sure", sure)
    judged = judged.withColumn("first", F.min(F.when(F.col("sure"), F.col("line"))).over(Window.partitionBy("key", "at"))).withColumn("sure", F.col("sure") & ((F.col("first") > 0) | (F.col("line") == 0)))
    best = F.max(F.when(F.col("sure"), F.struct("probability_", "family_")))
    found = judged.groupBy("key", "doc_id").agg(best.alias("best"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("sure"), F.col("family_")))), ",").alias("families"), F.count(F.when(F.col("sure"), 1)).alias("n_paragraphs"))
    return found.select("doc_id", F.coalesce("best.family_", F.lit(UNKNOWN)).alias("family"), F.col("best.probability_").alias("probability"), "families", "n_paragraphs")

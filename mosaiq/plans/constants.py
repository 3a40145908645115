"""Fixed values of the example requests, of the affinity matrix and of the answers that stand in for a model's."""

#: Affinity of archetypes with tags, 0 to 2.
AFFINITY = {
    "Arch_0": {"사회적 소비": 0, "적극적 소비": 1, "자기 중심적": 1, "윤리적 소비": 0, "소극적 실속": 2},
    "Arch_1": {"사회적 소비": 2, "적극적 소비": 2, "자기 중심적": 0, "윤리적 소비": 2, "소극적 실속": 1},
    "Arch_2": {"사회적 소비": 2, "적극적 소비": 1, "자기 중심적": 2, "윤리적 소비": 2, "소극적 실속": 0},
    "Arch_3": {"사회적 소비": 2, "적극적 소비": 2, "자기 중심적": 1, "윤리적 소비": 2, "소극적 실속": 1},
    "Arch_4": {"사회적 소비": 0, "적극적 소비": 0, "자기 중심적": 2, "윤리적 소비": 2, "소극적 실속": 2},
}
#: Requests: id, category, reasons, item, price.
SCENARIOS = (
    ("1", "문구·다꾸", ("그냥갖고싶음", "SNS광고"), "아이돌 탑꾸 소품 세트", 9000),
    ("2", "굿즈", ("친구추천", "그냥갖고싶음"), "뉴진스 포토카드 굿즈", 6000),
    ("3", "간식", ("SNS광고", "그냥갖고싶음"), "편의점 신상 젤리", 2500),
    ("4", "문구·다꾸", ("친구추천", "그냥갖고싶음"), "유행 신상 샤프", 4500),
    ("5", "간식", ("기타",), "편의점 삼각김밥", 1500),
    ("6", "간식", ("친구추천",), "탕후루", 3500),
    ("7", "굿즈", ("품절전에", "그냥갖고싶음"), "뉴진스 한정판 굿즈", 8500),
    ("1A", "문구·다꾸", ("그냥갖고싶음",), "탑로더와 하트 스티커", 5000),
    ("1B", "문구·다꾸", ("그냥갖고싶음",), "탑꾸 소품", 5000),
)
#: Answers by type of mentor, where no model is called.
ANSWERS = {
    1: "민지야, 다이소 진열대 앞에서 꽤 오래 고민하고 있구나? 🛍 오늘 미리 계획해둔 용돈 선 안에서 고른다면 어떤 게 딱 맞을 것 같아?",
    2: "옆에 서연이랑 같이 구경하니까 더 신나 보인다! 👭 둘이 함께 나눠 쓰거나 세트로 맞췄을 때 제일 마음이 따뜻해지는 건 뭘까?",
    3: "필통에 이미 친구들이 많은데 또 마음이 가는 게 있나 보네 ✏️ 이게 오랫동안 네 곁에서 진짜 쓸모 있게 남을 물건일지 한번 떠올려볼래?",
    4: "학원 가기 전 남은 시간이랑 토스 잔고를 딱 계산해 보고 있구나 📊 후회 없는 최고의 선택을 하려면 지금 뭘 고르는 게 제일 똑똑할까?",
    5: "남들 다 사는 거 말고 네 눈에 유독 반짝이는 게 있나 보다 🎨 그게 정말 네 방에 뒀을 때 너만의 분위기를 살려줄 특별한 아이템일까?",
}
